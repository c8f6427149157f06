"""Column functions; Pandas functions only where no built-in can express the semantics."""
