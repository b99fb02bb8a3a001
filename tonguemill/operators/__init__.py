"""DataFrame operators: segments, batches, answers, reassembly, layout, report."""
