"""Operators for building training corpora, as Spark jobs over tables of documents and pages."""
