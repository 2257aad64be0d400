"""Column functions: text analysis, vector arithmetic, stand-in encoders."""
