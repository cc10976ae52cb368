"""DataFrame operators: grid, support, folds, fits, risk, verdicts, lineage, quality."""
