"""Where sets are kept: by content and by name."""

from plyset.sources.catalog import Catalog

__all__ = ["Catalog"]
