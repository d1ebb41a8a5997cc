from tastemap.sources.tables import table

__all__ = ["table"]
