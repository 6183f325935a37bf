"""tabtext.operators."""
