"""Results written out: masked images, audit records."""
