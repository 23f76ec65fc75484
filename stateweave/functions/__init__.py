"""Column functions: text, dates, code tables, typed conversion and WKT geometry."""
