"""Structure analytics on Spark: programs as relations, rules as queries over them."""
