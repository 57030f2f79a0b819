"""Operators that Spark lacks: folds, geometry kernels and signatures."""
