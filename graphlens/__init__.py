"""graphlens: architecture property graphs and their audits as Spark DataFrames."""
