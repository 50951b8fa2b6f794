"""candela: market-structure analytics and corpus operators as Spark DataFrame jobs."""
