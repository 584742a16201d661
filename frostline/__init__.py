"""frostline: the life of cold table data as Spark DataFrame jobs."""
