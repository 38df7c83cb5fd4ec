"""DataFrame operators on panels, predictions, labels and masks."""
