"""Document-text analytics on Spark: DataFrame and Column operators that Catalyst plans."""
