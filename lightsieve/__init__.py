"""lightsieve: curating large media and text collections with Spark DataFrames."""
