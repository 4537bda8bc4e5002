"""Column functions: tokens, paths and vectors. All are built-in expressions, so plans stay in the JVM."""
