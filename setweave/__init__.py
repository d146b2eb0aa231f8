"""setweave: set operations, text sets and graph neighbourhoods as Spark plans."""
