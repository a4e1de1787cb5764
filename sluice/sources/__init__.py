"""Reading tables and keeping intermediate tables where every executor sees them."""
from .tables import shared_dir, table

__all__ = ["shared_dir", "table"]
