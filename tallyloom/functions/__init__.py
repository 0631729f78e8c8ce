"""Column -> Column rules: money, dates, names, replies and scores."""
