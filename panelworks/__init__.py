"""panelworks: analytics operators for gappy panels, predictions and weak labels, on Spark."""
