"""tabtext.plans."""
