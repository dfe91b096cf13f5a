"""atlasloom: searchable, publishable knowledge tables from many source repositories, on Spark."""

__version__ = "0.1.0"
