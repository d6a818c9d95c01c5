"""Named queries over the raw tables, and the same in SQL where SQL can express them."""
