"""Usage metering and billing of multi-tenant clusters as Spark jobs."""
