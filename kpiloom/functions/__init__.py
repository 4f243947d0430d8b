"""Column helpers and the fixed lookup values they use."""
