"""kpiloom: retail and workforce analytics as Spark jobs.

Raw tables become a star schema, the star answers a library of KPI queries and
guarded ad-hoc SQL, and three models (attrition risk, daily demand, order
anomalies) are trained and batch-scored from it.
"""
