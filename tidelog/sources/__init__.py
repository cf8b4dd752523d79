from tidelog.sources.cut import cut, shared_folder
from tidelog.sources.tables import latest_delivery, table

__all__ = ["cut", "latest_delivery", "shared_folder", "table"]
