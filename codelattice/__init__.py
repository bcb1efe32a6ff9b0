"""Code-graph analytics and hybrid symbol search on PySpark."""
