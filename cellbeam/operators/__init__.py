"""Operators over adaptive grids, rays, images and feature grids: DataFrame in, DataFrame out."""
