"""Table operators: cleaning, models/marts, window features, loads, quality, ledger, ML."""
