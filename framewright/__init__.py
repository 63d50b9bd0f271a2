"""framewright: dataset analytics for object-detection corpora as Spark DataFrame operators."""

__version__ = "0.1.0"
