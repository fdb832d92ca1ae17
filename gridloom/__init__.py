"""gridloom: planar drawing analytics and data preparation as Spark DataFrame plans."""
