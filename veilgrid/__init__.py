"""veilgrid: finding, classifying and rewriting sensitive values at table scale, and the analysis of the resulting log."""
