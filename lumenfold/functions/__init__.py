"""lumenfold subpackage."""
