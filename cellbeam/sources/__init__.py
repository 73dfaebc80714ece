"""Readers and writers of scene folders, arrays and volumes."""
