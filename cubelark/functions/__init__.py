"""Column functions: cleaning, categories, money, dates and exact aggregates. All are Catalyst expressions, no UDFs."""
