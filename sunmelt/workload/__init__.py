"""Named queries over the test tables, their SQL counterparts, and the comparison."""
