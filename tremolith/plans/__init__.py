"""Named queries over the supplied tables, with the SQL that defines their results."""
