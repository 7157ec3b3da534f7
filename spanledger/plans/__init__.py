"""Plan building blocks that stay even when one key holds most of the rows."""
