"""docquill: document analytics, retrieval and corpus preparation as Spark jobs."""
