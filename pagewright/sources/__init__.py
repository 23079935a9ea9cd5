"""Reading page tables, and the snapshot tables and exports jobs write."""
