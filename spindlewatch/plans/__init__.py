"""What a user calls: the reports, their SQL text, the batch job and the timing harness."""
