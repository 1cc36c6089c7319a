"""Column functions: token arrays, divergences, text scores, model output parsing."""
