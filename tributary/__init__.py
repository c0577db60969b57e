"""A Spark-native analytics engine: relational operators, planning toolkit, trace analytics, corpus operators."""
