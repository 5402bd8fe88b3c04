"""Evidence scoring, fusion and detector evaluation on Spark."""
