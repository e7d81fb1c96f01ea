"""Document-structure analytics on PySpark.

Page-grain data (lines, regions, tables, formulas, text layers) are tables and every operator maps
DataFrames to DataFrames. The subpackages are imported one by one; this module imports none of them.
"""
