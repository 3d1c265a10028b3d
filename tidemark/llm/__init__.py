"""Training-data operators. Nothing outside this folder imports it; the folder can be removed as a whole."""
