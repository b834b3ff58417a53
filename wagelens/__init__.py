"""wagelens: payroll-style analytics as Spark DataFrame plans (see README.md)."""
