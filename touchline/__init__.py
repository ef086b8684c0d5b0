"""touchline: match analytics, score models and pool tickets on Spark DataFrames."""
