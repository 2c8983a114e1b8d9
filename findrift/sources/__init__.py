"""Readers: SARIF logs, configuration, manifests, repository snapshots, labels, synthetic data."""
