"""Query plans: the store-day layer (the five views), the registered queries, their SQL
twins and the catalog."""
