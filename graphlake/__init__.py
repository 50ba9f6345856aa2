"""graphlake: property-graph analytics as Spark plans over vertex and edge DataFrames."""
