"""An extension that has no counterpart among the reference's operators: evidence that arrives as a stream."""
