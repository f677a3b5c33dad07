"""Palette operators: nearest colours, dithering, resampling, histograms and extraction."""
