"""Column functions; all are compositions of built-ins and stay in the JVM."""
