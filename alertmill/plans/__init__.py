"""Whole plans: driver queries over the test tables, audits of alerts, dependency scans."""
