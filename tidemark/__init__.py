"""An analytics engine on PySpark for keyed, loosely typed records and their history."""
