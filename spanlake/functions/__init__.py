"""Scalar building blocks: column expressions that stay inside the JVM, plus three Arrow UDFs."""
