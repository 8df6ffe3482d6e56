"""DataFrame operators for edit-action data: actions, canvases, buckets, batches and metrics."""
