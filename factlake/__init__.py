"""Program facts as DataFrames: capability sets, call graphs, code checks, reports."""
