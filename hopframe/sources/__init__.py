"""Where tables come from: named backends, table references, stored mappings."""
