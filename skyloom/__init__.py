"""Sky-catalogue analytics and corpus preparation on PySpark DataFrames."""
