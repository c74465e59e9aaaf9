"""Named queries over the given tables, each with equivalent SQL where there is one."""
