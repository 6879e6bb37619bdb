"""Water-mass analytics on long tables of gridded ocean data, as DataFrame functions."""
