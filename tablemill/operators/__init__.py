"""DataFrame -> DataFrame operators driven by plain configuration."""
