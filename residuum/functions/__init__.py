"""Column functions: vector maths, null rules, label text. All stay in the JVM."""
