"""Evidence catalog engine on Spark: flatten, publish, search and contextualise structured evidence records."""
