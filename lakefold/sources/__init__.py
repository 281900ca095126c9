from lakefold.sources.tables import table

__all__ = ["table"]
