"""The row-local operators over streams, and the repair loop by micro-batches."""
