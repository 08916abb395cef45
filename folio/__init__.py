"""folio: document-persuasion analytics as declarative PySpark operators."""

__version__ = "0.1.0"
