"""Operators over points, spheres, tiles and files."""
