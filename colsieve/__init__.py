"""colsieve: column subset selection and its experiment tooling on Spark DataFrames."""
