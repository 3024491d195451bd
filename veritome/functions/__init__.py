"""Scalar functions: native columns where Spark has the semantics, Arrow functions where it doesn't."""
