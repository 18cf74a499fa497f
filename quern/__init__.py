"""A PySpark engine for document conversion, planning and document-table queries."""

__version__ = "0.1.0"
