"""tessera: data work around language-model training, as Spark jobs."""

__version__ = "0.1.0"
