"""Source trees, manifests, snapshots and the incremental index."""
