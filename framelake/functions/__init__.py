"""Column functions: colour spaces, distances, dithering, small scalar rules."""
