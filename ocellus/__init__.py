"""ocellus: descriptor analytics and image-query retrieval on Spark DataFrames."""
