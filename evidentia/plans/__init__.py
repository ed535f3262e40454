"""Plan helpers: folds over ordered rows."""
