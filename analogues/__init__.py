"""Every operator run on the driver's tables, each next to the SQL that must give the same rows."""
